"""Sentence bank for the derived contract table: our own wording, one entry per slot.

The supplied documents hold almost no contract vocabulary, so the `contracts` table puts eight
bank entries in front of each document.  Entry i is picked by integer arithmetic, the same in
every engine.  The number of entries is coprime with both multipliers used.
"""

BANK = [
    "Either party may terminate this agreement for cause upon thirty days written notice to the other.",
    "The landlord reserves immediate termination of the tenancy without notice if any term is broken.",
    "Termination of the contract without cause obliges the tenant to cancel all open orders at once.",
    "The lease shall expire at the end of the agreed year unless the parties extend it in writing.",
    "Payment of the monthly rent is due on the first day, and late payment penalties accrue daily.",
    "The security deposit is non-refundable and every fee must be paid as an advance payment.",
    "The tenant shall pay each invoice within ten days; the price may rise after mutual agreement.",
    "Compensation for extra services follows the cost list attached to this contract.",
    "The supplier accepts unlimited liability for all damages, and there is no liability cap.",
    "Liability of either party stays below the liability cap of twelve monthly fees.",
    "The tenant shall indemnify the landlord under a broad indemnification for every loss and is liable for damages.",
    "The contractor is responsible for any limitation that a personal guarantee may cause.",
    "All confidential information is subject to perpetual confidentiality with no exceptions.",
    "The recipient keeps every trade secret and signs the non-disclosure form in good faith.",
    "Proprietary data falls under a broad definition and the nda binds the staff as well.",
    "All intellectual property made under this contract is a work for hire with no retained rights.",
    "A broad IP assignment covers every patent, trademark and copyright created by the contractor.",
    "Ip rights in earlier works stay with their owner, who grants an exclusive licence.",
    "Any dispute goes to mandatory arbitration with a limited venue and a waiver of jury trial.",
    "Mediation comes before litigation, and the court of the city decides as the last instance.",
    "The parties waive their appeal, which the tenant calls a waiver of rights, before any court.",
    "Force majeure has a narrow definition here and grants no relief provisions to the supplier.",
    "An act of god or a natural disaster suspends all obligations after a short notice period.",
    "Unforeseeable events release both parties while the cure period runs.",
    "The governing law is foreign law chosen by the landlord alone.",
    "The applicable law and the jurisdiction follow the seat of the supplier, an inconvenient venue for the tenant.",
    "The duration of the lease is five years with auto-renewal of the contract for the same period.",
    "The term shall commence in March and run for eleven months; no early termination is allowed.",
    "The lease period is a long term commitment of ten years.",
    "Internal maintenance and all structural repairs are a tenant responsibility under broad maintenance obligations.",
    "The lessee maintains the interior and its upkeep; there is no landlord responsibility.",
    "Repairs below the limit are carried out by the tenant in a commercially reasonable way.",
    "No alterations allowed: additions and improvements need consent, and landlord approval required for changes.",
    "Modifications and structural changes create restoration obligations at the end of the lease.",
    "The tenant may make alterations that meet the industry standard after written consent.",
    "Assignment of this contract is excluded; landlord consent required and personal guarantees apply.",
    "The tenant may not sublet or transfer the flat; subletting means that the deposit is forfeit.",
    "The supplier may assign its claims; no assignment allowed for the buyer.",
    "The landlord decides in its sole discretion on approval and consent.",
    "The owner may change the house rules without notice and modify the fee list.",
    "Payment is immediate and binding; any penalty is irrevocable.",
    "Both sides act in good faith and give reasonable notice of mutual delays.",
    "INDIA NON JUDICIAL\nGOVERNMENT OF KARNATAKA\ne-Stamp Certificate No. IN-KA12345\nSTAMP PAPER",
    "STATE OF DELHI\nREVENUE STAMP\nAadhar No: 123412341234\nPAN No. ABCDE1234F",
    "Document No: DOC778 Serial No. 991\nRegistration No: R5512\nSub Registrar Office",
    "PAGE 3 OF 9\n17\n[ 4 ]\nDRAFT COPY",
    "|| ___ ------- ..... \nNAME : ANITA\n| rent | 500 |\n-----",
    "Rs. 500\n12/03/2021\nABC DEF\nRENT AGREEMENT",
    "IN WITNESS WHEREOF the parties have signed and delivered this deed, witnessed by two adults.",
    "Notarized by the public notary; sworn before me, subscribed and sworn, official seal and signature.",
    "WHEREAS the lessor and the lessee hereby agree on the following conditions of this rental contract.",
    "The party of the first part keeps its rights and obligations; therefore it remains in possession.",
    "aaaaa bbbb ....... noise ____ and ---- marks (see the annex).",
    "Ministry of Housing, Department of Lands\n○ ● ○\n░▒▓\n└──┘",
    "Insurance and utilities are shared; delivery and surrender happen on the day of renewal or extension.",
    "Default or breach of these terms ends the assignment, and the notice period starts anew.",
    "The weather was fine and the garden was full of flowers.",
    "Nothing in this paragraph is of any legal weight and it only fills the page.",
    "The parties met at noon and shared a long lunch with the neighbours before they walked along the river and "
    "talked about the term of the old agreement, the colour of the doors, the height of the trees, the number of "
    "rooms and the many guests who had come from far away to see the house and its wide garden in late summer.",
]
assert len(BANK) == 59
